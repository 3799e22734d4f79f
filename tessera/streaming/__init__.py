"""Structured Streaming jobs and their batch twins (STM operators)."""
