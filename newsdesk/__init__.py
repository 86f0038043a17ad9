"""Spark jobs for news curation: articles, stories, editions, archive, publication."""
