"""tickloom: event-window analytics on Spark DataFrames."""
