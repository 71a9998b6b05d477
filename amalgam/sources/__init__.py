"""Readers of customer data and of what earlier runs stored."""
