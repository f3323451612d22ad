"""Streaming: intentionally empty.

The studied pipeline has no stream, watermark, trigger or late-data handling;
its "real-time" path is a request/response lookup, which this library serves
from precomputed recommendation tables (``operators.recommend.cache_lookup``).
Nothing is built here so as not to add operators the reference does not have.
"""
