"""Crawl replay and caches on Structured Streaming."""
