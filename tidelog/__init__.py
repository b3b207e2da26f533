"""Tidelog: PySpark-native analysis of transaction logs, and operators for text corpora in the subpackage llm."""
