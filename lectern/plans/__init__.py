"""The registered queries; importing the modules registers them."""
