"""Preparing text for model training: ten operators over a table of documents.

Each operator is a function from DataFrame to DataFrame. Nothing else in the library imports this folder.
"""
