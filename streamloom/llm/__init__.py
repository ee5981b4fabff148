"""Training-data operators: text, URL, archive, mixing and language-model stages."""
