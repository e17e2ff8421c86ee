"""DataFrame operators: DataFrame -> DataFrame, or fitted objects with fit/transform."""
