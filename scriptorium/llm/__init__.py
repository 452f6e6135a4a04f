"""Training-data operators: near-dedup, search, packing, media, token files, language ID, chat, mixing."""
