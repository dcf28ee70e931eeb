"""skein: hybrid retrieval and corpus analytics as DataFrame programs."""

__version__ = "0.1.0"
