"""tracelet: DataFrame operators for entities that move, divide and disappear."""
