"""Conversation-state analytics on Spark DataFrames."""
