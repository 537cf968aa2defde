"""Writers: messages, lake tables, logs, the feature store."""
