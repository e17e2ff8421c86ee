"""Plans: master build, named reports, model comparison, segmentation, query registry."""
