"""Training-data operators: near and exact dedup, decontamination, classifiers, packing.

Nothing outside this package imports it.  Every operator takes a DataFrame and
returns a DataFrame; thin queries over the shared tables live in ``queries``.
"""
