"""Training-data operators (language-model scoring, near-dedup, tokenising ...).

One module per operator; ``queries`` registers them.  Nothing else in the
library imports this subpackage.
"""
