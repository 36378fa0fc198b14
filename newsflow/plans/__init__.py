"""The five analyses. Each takes a DataFrame and returns one; given a streaming
DataFrame the same call gives the streaming plan."""
