"""DataFrame -> DataFrame operators; none of them triggers an action."""
