"""Weekly retail replenishment on Spark: mart, features, models, decisions, KPIs."""
