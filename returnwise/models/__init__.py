"""Purchase-count and spend models: likelihoods over Spark, forecasts as columns."""
