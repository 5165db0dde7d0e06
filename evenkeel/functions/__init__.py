"""Column expressions: quantities, display text, label matching and binding."""

from .labels import bind_override, match_labels, render_query, url_host
from .quantity import parse_quantity, plain_text

__all__ = ["bind_override", "match_labels", "parse_quantity", "plain_text", "render_query", "url_host"]
