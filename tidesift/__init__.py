"""tidesift: scanning large collections of text, source trees and workflow files with Spark DataFrames."""

__version__ = "0.1.0"
