"""DataFrame operators over line, event, symbol and edge facts."""
