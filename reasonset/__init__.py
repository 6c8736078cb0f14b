"""Curation and evaluation of reasoning-conversation corpora as Spark DataFrame jobs."""
