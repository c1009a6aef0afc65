"""Analytics for camera-network event data on Spark: trajectories, alerts, evidence, search, datasets, evaluation."""
