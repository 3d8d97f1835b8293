"""Training-data operators: packing, deduplication, scoring, media, mixing, scanning, search, chat."""
