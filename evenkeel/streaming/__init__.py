"""Structured Streaming forms of the evaluation, of counter growth and of gauge peaks."""

from .election import elect_stream
from .growth import growth_stream, sliding_quantile_stream
from .peaks import peak_stream, quantile_stream

__all__ = ["elect_stream", "growth_stream", "peak_stream", "quantile_stream", "sliding_quantile_stream"]
