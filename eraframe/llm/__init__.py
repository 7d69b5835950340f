"""Preparation of training text: ten corpus operators on Spark DataFrames.

Each module holds one operator with its own interface. ``queries`` applies them
to whole tables. Nothing outside this folder and ``corpus_pipeline.py`` uses it.
"""
