"""Named query plans and the registry that orders them."""
