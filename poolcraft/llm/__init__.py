"""Operators for text collections used to train and judge language models.

Nothing outside this folder imports it.
"""
