"""Conversation-log analytics and training-data preparation on Spark."""
