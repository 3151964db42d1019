"""Structured Streaming: a store that grows as record files arrive."""
