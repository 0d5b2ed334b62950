"""Match analytics on Spark: point-in-time features, models and prediction over whole tables."""
