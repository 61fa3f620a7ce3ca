"""Transaction-risk analytics as DataFrame operators."""
