"""Cohort studies on Spark: manifests, folds, voxel features, evaluation and data preparation."""

__version__ = "0.1.0"
