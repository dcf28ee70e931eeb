"""skein.functions."""
