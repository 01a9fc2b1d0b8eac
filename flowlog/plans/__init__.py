"""Whole reports and jobs put together from the operators."""
