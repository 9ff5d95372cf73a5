"""Conversation-context analytics as Spark DataFrame jobs."""
