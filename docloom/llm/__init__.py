"""Training-data operators: packing, media, near-duplicates, archives, chat, language, toxicity,
main text, decontamination and sharding. Nothing outside this subpackage imports it."""
