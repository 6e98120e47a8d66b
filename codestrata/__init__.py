"""Analytics over code graphs as DataFrame plans."""
