"""Operators for preparing large training corpora on Spark.

Each module holds one operator with a general DataFrame interface; ``queries``
applies them to the tables of a data folder. Nothing outside this subpackage
imports it.
"""
