"""Training-data operators: mixing, formatting, token counts, filters, de-duplication and packing."""
