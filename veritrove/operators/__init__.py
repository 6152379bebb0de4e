"""Rules and profiling operators."""
