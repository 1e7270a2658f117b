"""Operators: plain functions ``(DataFrame..., params) -> DataFrame``."""
