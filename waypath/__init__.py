"""Event-chain analytics and corpus preparation on Spark."""
