"""Training-data operators: quality, de-duplication, decontamination, privacy, language, chat and tokens."""
