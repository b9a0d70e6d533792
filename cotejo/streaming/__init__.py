"""Stateful folds over ordered events, for batches and for streams."""
