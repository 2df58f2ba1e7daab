"""Training-data operators: packing, search, chat formatting, language, near-duplicates, quality, licences, URLs and byte-level BPE."""
