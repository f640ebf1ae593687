"""Weftline: deterministic, resumable training-batch streams as Spark plans."""

CONTRACT_VERSION = 1

__all__ = ["CONTRACT_VERSION"]
