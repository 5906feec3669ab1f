"""Generic operators; keys, times and measures are arguments."""
