"""Training-data operators: one module per operator, each with its thin ``opN_<name>`` query."""
