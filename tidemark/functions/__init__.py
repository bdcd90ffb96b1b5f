"""Scalar expressions and tokenizers."""
