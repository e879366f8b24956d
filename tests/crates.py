"""Small crates of our own for the scanner."""

SHOP = {
    "Cargo.toml": '[package]\nname = "shop-core"\n[dependencies]\nrusqlite = "1"\nserde_json = "1"\n[[bin]]\nname = "ghost"\n[[example]]\nname = "demo"\n',
    "src/lib.rs": "pub mod domain;\npub mod infra;\npub mod application;\n",
    "src/domain/mod.rs": """pub mod ports;
pub mod use_cases;

/// Something that is sold.
#[derive(Debug, PartialEq)]
pub struct Item {
    pub id: u64,
    name: String,
}

pub enum Mode { Open(u8), Shut }

impl Item {
    pub fn label(&self) -> String { self.name.clone() }
    pub fn price(&self, r: &str) -> u64 { self.id.checked_mul(2).unwrap() }
    pub fn fresh() -> Self { Self { id: 1, name: String::new() } }
}
""",
    "src/domain/ports/mod.rs": "use super::Item;\n\npub trait ItemStore {\n    fn find(&self, id: u64) -> Option<Item>;\n    fn save(&mut self, item: &Item);\n}\n",
    "src/domain/use_cases/mod.rs": """use crate::domain::ports::ItemStore;
use crate::domain::{self, Item, Mode as How};

pub fn find_item(store: &impl ItemStore, id: u64) -> Option<Item> { store.find(id) }

pub fn add_item<S: ItemStore>(store: &mut S, how: How) {
    let item = Item::fresh();
    store.save(&item);
    match how { How::Open(_) => {} How::Shut => {} }
    std::fs::read("x").unwrap();
}

#[cfg(test)]
mod tests {
    use super::*;
    use crate::domain::ports::ItemStore;
    #[test]
    fn finds() { find_item(&Fake, 1); }
    struct Fake;
    impl ItemStore for Fake { fn find(&self, _: u64) -> Option<Item> { None } fn save(&mut self, _: &Item) {} }
}
""",
    "src/infra/mod.rs": """use crate::domain::{ports::ItemStore, Item};
use rusqlite::Connection;

pub struct SqlStore { conn: Connection, cache: Vec<Item> }
pub struct Pool { slot: Missing }

impl ItemStore for SqlStore {
    fn find(&self, id: u64) -> Option<Item> { self.conn.query(id) }
    fn save(&mut self, item: &Item) { self.cache.push(item.label()); }
}
""",
    "src/application/mod.rs": """use crate::infra::SqlStore;
use crate::domain::use_cases::*;

static mut COUNT: u32 = 0;

pub fn run_add(store: &mut SqlStore) { add_item(store, todo!()); }

pub fn render_all(app: &App) -> String { format!("{} {}", app.list.items.len, app.title) }

pub struct App { list: Missing }
macro_rules! nothing { () => {} }
""",
    "tests/flow.rs": "use shop_core::domain::Item;\n\n#[test]\nfn flows() { let i = Item::fresh(); i.label(); }\n",
}

TORTURE = {
    "Cargo.toml": '[package]\nname = "torture"\n',
    "src/main.rs": '''//! inner
use std::{fmt::{self, Display}, io as sysio};
mod gone;
/* a /* nested */ comment */
const RAW: &str = r#"fn fake() { "x" }"#;
fn main() { let c = 'x'; let s = "}{"; let v = Vec::<u8>::with_capacity(3); helper::<u8>(&v); }
fn helper<'a, T>(v: &'a [T]) -> Box<dyn Fn(u8) -> Result<T, fmt::Error> + 'a> where T: Clone + Display { loop {} }
struct Wrap<T>(T, pub u8);
impl<T> fmt::Debug for Wrap<T> { fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, "{}", self.0) } }
''',
    "src/broken.rs": "fn {",
}
