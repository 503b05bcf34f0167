"""Training-data operators: cleaning, matching, classifying and mixing text at corpus scale.

Nothing else in the library imports this subpackage.
"""
