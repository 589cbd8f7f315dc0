"""DataFrame operators: selection, alignment, fact samples, perplexity, reports, rows."""
