"""Operators for cleaning text that language models are trained on."""
