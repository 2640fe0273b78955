"""postlens: social-post engagement analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
