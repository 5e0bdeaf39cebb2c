"""Plan shapes that keep hot keys and long windows distributed."""
