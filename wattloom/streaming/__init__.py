"""The online forms of the operators as Structured Streaming queries."""
