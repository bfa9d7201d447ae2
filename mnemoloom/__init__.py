"""Semantic-memory analytics on DataFrames: search, geometry, event folds, graph spreading and reports."""
