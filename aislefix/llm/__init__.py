"""Operators for preparing training text: extraction, language, archives, tokens, quality, copies, mixing, packing, chat."""
