"""What findings mean, in a sentence each."""

from __future__ import annotations

EXPLANATIONS = {
    "tiny-dataset": "So few rows that most statistics are guesses.",
    "duplicate-rows": "Equal rows count twice in every statistic and may stand on both sides of a split.",
    "empty-column": "No value at all; nothing can be learned from it.",
    "constant-column": "One value everywhere; it tells rows apart by nothing.",
    "high-missing": "At least half of the values are missing; filling them would invent the column.",
    "missing": "Some values are missing; decide how to fill them, or drop the rows.",
    "identifier-like": "Every value is different, as in a key; a model would memorise it.",
    "high-cardinality": "Very many levels; one column per level would be wide and thin.",
    "high-skew": "A long tail; a logarithm or clipping may help.",
    "outliers": "Values far outside the middle half.",
    "duplicate-columns": "The same values under two names.",
    "highly-correlated": "Two columns that carry nearly the same signal.",
    "analysis-skipped": "Too many columns to compare in pairs; nothing was looked for there.",
    "numeric-stored-as-text": "Numbers written as text; cast them first.",
    "datetime-stored-as-text": "Dates written as text; cast them first.",
    "mixed-types": "Values of several types in one column.",
    "class-imbalance": "One class is rare; accuracy will flatter.",
    "leakage-suspect": "A feature that all but states the target; ask when it is known.",
    "column-removed": "A column of the baseline is gone; what reads it will fail.",
    "column-added": "A column that the baseline does not have.",
    "type-changed": "The column's kind is another one now.",
    "missingness-changed": "The share of missing values moved.",
    "distribution-shifted": "The mean moved by a notable part of the baseline's spread.",
    "cardinality-changed": "The number of levels changed by half or more.",
    "new-categories": "A level among the most frequent that was not there before.",
    "category-share-changed": "The most frequent level's share moved.",
    "row-count-changed": "Less than half, or more than twice, the rows.",
    "beats-baseline": "Better than guessing.",
    "below-baseline": "No better than guessing.",
    "suspiciously-perfect": "Too good; look for leakage.",
    "wide-interval": "The estimate is uncertain; more rows are needed.",
    "single-class-predictions": "The model always says the same.",
    "miscalibrated": "Scores can't be read as probabilities.",
    "slice-gap": "The model serves some groups much worse.",
    "small-evaluation-set": "Few rows to judge by.",
    "no-clear-winner": "The leader's lead may be luck.",
    "model-failed": "A model could not be fitted; the others stand.",
}
