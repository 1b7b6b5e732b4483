"""Training-data operators: tokenising, filtering, de-duplication and extraction over whole document tables."""
