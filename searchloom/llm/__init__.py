"""Training-data operators: near duplicates, quality, decontamination, url
filters, toxicity, token files, mixing, chat windows, token counts, secrets."""
