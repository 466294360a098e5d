"""Operators that prepare training data for language models. Nothing outside of this subpackage imports it."""
