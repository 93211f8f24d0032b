"""Operators for preparing training text at scale: each module is one operator, ``queries`` registers them."""
