"""Incremental loads driven by Structured Streaming micro-batches."""

from .micro_batch import load_trip_batch, stream_trips, load_weather_batch, stream_weather

__all__ = ["load_trip_batch", "stream_trips", "load_weather_batch", "stream_weather"]
