"""Retrieval and conversation analytics over whole tables, written for Spark."""
