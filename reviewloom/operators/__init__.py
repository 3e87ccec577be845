"""DataFrame to DataFrame building blocks; none of them runs an action."""
