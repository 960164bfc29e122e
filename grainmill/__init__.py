"""Spark-native engine that turns source trees and document tables into text chunks."""

__version__ = "0.1.0"
