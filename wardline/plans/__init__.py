"""Policy specifications, and the compiler that turns an ordered list of them into a plan."""
