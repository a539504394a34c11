"""Training-data operators: search, filters, de-duplication, tokenisation, archives."""
