"""Training-data operators and their registered queries; nothing else in the library imports this."""
