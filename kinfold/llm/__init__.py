"""Operators that prepare text collections for training; nothing else in kinfold imports them."""
