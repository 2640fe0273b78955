"""Sources and sinks."""
from .csv import read_comments, read_posts  # noqa: F401
from .sinks import register_view, write_features  # noqa: F401
