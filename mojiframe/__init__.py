"""mojiframe: Spark-native analytics for labelled short-text corpora.

Text variants that keep, remove, spell out or isolate emoji; exact
stratified splits; TF-IDF + logistic-regression baselines; fusion arithmetic
on embedding columns; and grouped evaluation of many prediction runs.
"""

__version__ = "0.1.0"
