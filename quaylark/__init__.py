"""Market, news and training-data analytics as plain ``DataFrame -> DataFrame`` functions."""
