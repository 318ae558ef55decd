"""Learning-history analytics on Spark: features, datasets, models, selection and review streams."""
