"""Training-data operators: filters, classifiers, duplicate search, decontamination, tokens and media columns.

Nothing outside this folder imports it. Each operator module has a general function on DataFrames; ``queries``
derives the registered results from them.
"""
