"""Topics, feed files and views over the test tables."""
