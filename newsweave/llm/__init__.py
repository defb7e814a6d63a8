"""Training-data operators: token output, de-duplication, filtering and mixing of documents."""
